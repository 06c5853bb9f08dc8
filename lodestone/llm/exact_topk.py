"""Exact top-k search by inner product on M-trees.

A vector x of integers becomes (x, sqrt(M^2 - |x|^2)), M being the greatest norm, and a query q becomes (q, 0): their Euclidean
distance falls as the inner product grows, so the nearest neighbours in this metric space have the highest scores.

The top page of the tree holds at most `max_pivots` sampled vectors; each vector goes to its nearest one, and a pivot's
vectors, salted where they exceed `block`, form subtrees of paged nodes: entries with a pivot, a covering radius and the distance to the
parent's pivot. Best-first search skips an entry without computing its distance where |d(q, parent) - d(entry, parent)|
already exceeds the bound plus the radius. Each query first searches its own pivot's subtrees; with the bound that gives, it goes on only to
those pivots whose covering ball it can still reach. Queries meet subtrees in blocks. Scores are exact integers, bounds carry a margin for rounding.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with a
null id; only vectors of a query's own length are its candidates, and none with its own id; repeated rows each count as a candidate, and a repeated id asks
once, with its least vector; fewer candidates than k give all of them; equal scores rank by the smaller id, then the smaller vector; an empty table
gives an empty result. A score beyond 2^53 in any partial sum is added up in whole numbers of any size and must fit a long.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE = 64.0
K = 20
PAGE = 256  # entries of a node
BLOCK = 8192  # vectors of a subtree
QUERIES = 2048  # queries that meet a subtree at once
MAX_PIVOTS = 256  # sampled for the top page


def augmented(v, most: float):
    """v with the component that brings each row's norm to sqrt(most)."""
    import numpy as np

    return np.concatenate((v, np.sqrt(np.maximum(most - (v * v).sum(1), 0.0))[:, None]), 1)


class Node:
    """A page: entries' pivots (all coordinates), their distance to the page's own pivot, radii and children; or a leaf's vectors."""

    __slots__ = ("children", "points", "radius", "rows", "to_parent")

    def __init__(self, points, rows, centre) -> None:
        import numpy as np

        self.children = self.radius = None
        if len(rows) <= PAGE:
            self.points, self.rows = points, rows
        else:
            fan = min(PAGE, max(2, math.isqrt(len(rows)) // 2))
            step = len(rows) / fan
            pivots = points[[int(i * step) for i in range(fan)]]
            square = (points * points).sum(1)[:, None] - 2 * points @ pivots.T + (pivots * pivots).sum(1)[None]
            near = square.argmin(1)
            own = [np.flatnonzero(near == i) for i in range(fan)]
            if max(map(len, own)) == len(rows):  # vectors that pivots can't tell apart
                own = [x for x in np.array_split(np.arange(len(rows)), fan) if len(x)]
                pivots = points[[x[0] for x in own]]
            else:
                pivots, own = pivots[[i for i, x in enumerate(own) if len(x)]], [x for x in own if len(x)]
            self.points, self.rows = pivots, None
            self.children = [Node(points[x], rows[x], p) for p, x in zip(pivots, own, strict=True)]
            self.radius = np.array([math.sqrt(max(0.0, float(((points[x] - p) ** 2).sum(1).max()))) for p, x in zip(pivots, own, strict=True)])
        self.to_parent = np.sqrt(((self.points - centre) ** 2).sum(1))


def exact_scores(vectors, q):
    """Inner products: of doubles where these are exact, else of Python integers."""
    import numpy as np

    if float(np.abs(vectors).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q) < 2**53:
        return (vectors @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([sum(int(a) * b for a, b in zip(v, whole, strict=True)) for v in vectors], np.int64)


def search(root: Node, centre, vectors, ids, q, own: int, k: int, most: float, floor: float | None):
    """Places in vectors of the k best for one query, with their scores, in whole numbers of any size; none below `floor`, a score
    that k others have reached elsewhere."""
    import numpy as np

    norm = float(q @ q)
    point = np.append(q, 0.0)
    margin = 1e-7 * (1 + math.sqrt(norm + most))
    reach = lambda score: math.sqrt(max(0.0, norm + most - 2 * score)) + margin
    bound = math.inf if floor is None else reach(floor)
    place, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    heap = [(0.0, 0, root, math.sqrt(float(((point - centre) ** 2).sum())))]
    count = 1
    while heap:
        least, _, node, to_pivot = heapq.heappop(heap)
        if least > bound:
            break
        gap = np.abs(to_pivot - node.to_parent)
        if node.children is None:
            some = node.rows[gap <= bound + margin]
            some = some[ids[some] != own]
            if len(some):
                scores = exact_scores(vectors[some], q)
                place, found = np.concatenate((place, some)), np.concatenate((found, scores))
                keep = np.lexsort((ids[place], -found))[:k]
                place, found = place[keep], found[keep]
                if len(found) == k:
                    bound = min(bound, reach(float(found[-1])))
        else:
            open_ = np.flatnonzero(gap <= bound + node.radius + margin)
            far = np.sqrt(((node.points[open_] - point) ** 2).sum(1))
            for i, d in zip(open_.tolist(), far.tolist(), strict=True):
                low = max(0.0, d - float(node.radius[i]) - margin)
                if low <= bound:
                    heapq.heappush(heap, (low, count, node.children[i], d))
                    count += 1
    return place, found


def leaves(node: Node, to_pivot, least, bound, points, margin, out: list) -> list:
    """Leaves that some query can reach: (leaf, each query's least distance to its vectors, and distance to its pivot), infinite where it can't."""
    import numpy as np

    if node.children is None:
        out.append((node, least, to_pivot))
        return out
    low = np.abs(to_pivot[:, None] - node.to_parent[None]) - node.radius[None] - margin[:, None]
    reach = (low <= bound[:, None]) & (least <= bound)[:, None]  # the others' distances are never computed
    for i in np.flatnonzero(reach.any(0)).tolist():
        some = np.flatnonzero(reach[:, i])
        far = np.full(len(bound), np.inf)
        far[some] = np.sqrt(((points[some] - node.points[i]) ** 2).sum(1))
        leaves(node.children[i], far, np.maximum(far - node.radius[i] - margin, least), bound, points, margin, out)
    return out


def search_block(root: Node, centre, vectors, ids, queries, own, k: int, most: float, floors):
    """search() for a block of queries at once: (query, place, score) of each one's k best. In round r every query that still can
    gain looks into its r-th nearest leaf; a leaf serves its queries together. vectors must be in order of ids, and scores below 2^53."""
    import numpy as np

    n = len(queries)
    norm = (queries * queries).sum(1)
    points = np.concatenate((queries, np.zeros((n, 1))), 1)
    margin = 1e-7 * (1 + np.sqrt(norm + most))
    reach = lambda rows, score: np.sqrt(np.maximum(norm[rows] + most - 2 * score, 0.0)) + margin[rows]
    bound = np.where(np.isnan(floors), np.inf, reach(slice(None), np.nan_to_num(floors)))
    found = leaves(root, np.sqrt(((points - centre) ** 2).sum(1)), np.zeros(n), bound, points, margin, [])
    width = max(1, int(len(ids)).bit_length())
    none = np.iinfo(np.int64).min
    keys = np.full((n, k), none, np.int64)  # score and place in one number: the smaller place is the greater key
    if found:
        low = np.stack([x for _, x, _ in found], 1)
        order = np.argsort(low, 1, kind="stable")
        for r in range(len(found)):
            turn = order[:, r]
            live = np.flatnonzero(low[np.arange(n), turn] <= bound)
            if not len(live):
                break
            for leaf in np.unique(turn[live]).tolist():
                rows = live[turn[live] == leaf]
                node, _, to_pivot = found[leaf]
                near = np.abs(to_pivot[rows][:, None] - node.to_parent[None]) <= (bound[rows] + margin[rows])[:, None]
                cols = np.flatnonzero(near.any(0))
                if not len(cols):
                    continue
                place = node.rows[cols]
                scores = np.rint(queries[rows] @ vectors[place].T).astype(np.int64)
                new = (scores << width) + ((1 << width) - 1 - place)[None]
                new[(ids[place][None] == own[rows][:, None]) | ~near[:, cols]] = none
                every = np.concatenate((keys[rows], new), 1)
                keys[rows] = -np.partition(-np.maximum(every, none + 1), k - 1, 1)[:, :k]
                last = keys[rows].min(1)
                full = last > none + 1
                bound[rows[full]] = np.minimum(bound[rows[full]], reach(rows[full], (last[full] >> width).astype(np.float64)))
    query, column = np.nonzero(keys > none + 1)
    key = keys[query, column]
    return query, (1 << width) - 1 - (key & ((1 << width) - 1)), key >> width


def _matrix(column):
    """The lists of an Arrow column, all of one length, as rows of doubles."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id, v (whole numbers, as doubles), dim, norm (squared)."""
    v = F.transform(F.col(vector_col), lambda x: _floor(x.cast("double") * scale))
    sound = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col)).filter(F.col("vec_id").isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).filter(sound)
    rows = rows.select("vec_id", v.alias("v"))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("norm"))


def _floor(x):
    """floor(x) as a double, whatever its size."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _assigned(rows: DataFrame, pivots, most: float) -> DataFrame:
    """rows with `pivot`, the nearest one, and `far`, the distance from it (of the point with its own extra coordinate)."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            p = augmented(_matrix(batch.column(1)), most)
            square = (p * p).sum(1)[:, None] - 2 * p @ pivots.T + (pivots * pivots).sum(1)[None]
            near = square.argmin(1)
            far = np.sqrt(((p - pivots[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(far)], ["vec_id", "v", "pivot", "far"])

    return rows.select("vec_id", "v").mapInArrow(work, "vec_id long, v array<double>, pivot int, far double")


def _found(queries: DataFrame, data: DataFrame, pivots, most: float, k: int) -> DataFrame:
    """The k best of each meeting of queries (query_id, q, floor) and data (vec_id, v) by pivot, salt and part."""

    def work(key, left, right):
        import numpy as np
        import pyarrow as pa

        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            vectors, ids = _matrix(right.column("v")), np.asarray(right.column("vec_id"))
            order = np.lexsort((*vectors.T[::-1], ids))  # so that results don't depend on the order of arrival
            vectors, ids = vectors[order], ids[order]
            centre = pivots[key[0].as_py()]
            root = Node(augmented(vectors, most), np.arange(len(ids)), centre)
            asked, q = np.asarray(left.column("query_id")), _matrix(left.column("q"))
            floors = np.asarray(left.column("floor").cast(pa.float64()).fill_null(math.nan))
            largest = float(np.abs(vectors).max()) * float(np.abs(q).max()) * q.shape[1]
            if largest < 2.0 ** (53 - max(1, len(ids).bit_length())):
                query, place, score = search_block(root, centre, vectors, ids, q, asked, k, most, floors)
                return pa.table({"query_id": asked[query], "vec_id": ids[place], "score": score})
            for own, x, floor in zip(asked.tolist(), q, floors.tolist(), strict=True):
                place, scores = search(root, centre, vectors, ids, x, own, k, most, None if math.isnan(floor) else floor)
                out["query_id"] += [own] * len(place)
                out["vec_id"] += ids[place].tolist()
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    keys = ["pivot", "salt", "part"]
    return queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(work, "query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _of_length(rows: DataFrame, count: int, most: float, asks, k: int, max_pivots: int) -> DataFrame:
    """Top k among `count` vectors of one length."""
    import numpy as np

    want = max(1, min(max_pivots, count // (BLOCK // 2)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(want).select("v").toArrow()  # max_pivots rows at most
    pivots = np.unique(augmented(_matrix(sample.column("v")), most), axis=0)
    data = cut(_assigned(rows, pivots, most))
    ask = data.filter(asks(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("q"), F.min_by("pivot", "v").alias("home"))
    sizes = {r["pivot"]: r for r in data.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # a row a pivot
    number = len(pivots)
    salts = [-(-sizes[p]["n"] // BLOCK) if p in sizes else 0 for p in range(number)]
    radius = np.array([sizes[p]["radius"] if p in sizes else -math.inf for p in range(number)])
    by_pivot = lambda values, p: F.get(F.array(*map(F.lit, values)), p)

    def meet(pairs: DataFrame) -> DataFrame:
        """pairs: query_id, q, floor, pivot."""
        pairs = cut(pairs)
        asked = {r["pivot"]: r["n"] for r in pairs.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # a row a pivot
        parts = [-(-asked.get(p, 0) // QUERIES) for p in range(number)]
        left = pairs.withColumn("part", F.pmod(F.xxhash64("query_id"), by_pivot([max(1, x) for x in parts], F.col("pivot"))).cast("int"))
        left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), by_pivot([max(1, x) for x in salts], F.col("pivot")) - 1)))
        right = data.select("vec_id", "v", "pivot", F.pmod(F.xxhash64("vec_id", "v"), by_pivot([max(1, x) for x in salts], F.col("pivot"))).cast("int").alias("salt"))
        right = right.filter(by_pivot([x > 0 for x in parts], F.col("pivot"))).withColumn("part", F.explode(F.sequence(F.lit(0), by_pivot([max(1, x) for x in parts], F.col("pivot")) - 1)))
        return cut(_found(left, right, pivots, most, k))

    first = meet(ask.select(F.col("vec_id").alias("query_id"), "q", F.lit(None).cast("double").alias("floor"), F.col("home").alias("pivot")))
    floors = _top(first, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    rest = ask.withColumnRenamed("vec_id", "query_id").join(floors, "query_id", "left").select("query_id", "q", "floor", "home")

    def reachable(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1))
            point = np.concatenate((q, np.zeros((len(q), 1))), 1)
            far = np.sqrt(((point[:, None, :] - pivots[None]) ** 2).sum(2)) if len(q) * pivots.size < 5e7 else np.stack([np.sqrt(((point - p) ** 2).sum(1)) for p in pivots], 1)
            floor = np.array([-math.inf if x is None else x for x in batch.column(2).to_pylist()])
            norm = (q * q).sum(1)
            bound = np.sqrt(np.maximum(norm + most - 2 * floor, 0.0)) + 1e-6 * (1 + np.sqrt(norm + most))
            go = far - radius[None] <= bound[:, None]
            go[np.arange(len(q)), np.asarray(batch.column(3))] = False
            row, pivot = np.nonzero(go)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), taken.column(2), pa.array(pivot.astype(np.int32))], ["query_id", "q", "floor", "pivot"])

    more = meet(rest.mapInArrow(reachable, "query_id long, q array<double>, floor double, pivot int"))
    return _top(first.unionByName(more), k)


def top_k(vectors: DataFrame, asks, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = SCALE, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each row whose id column `asks` accepts, against all other rows."""
    rows = cut(_scaled(vectors, id_col, vector_col, scale))
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()  # a row a length of vectors
    found = None
    for r in lengths:
        part = _of_length(rows.filter(F.col("dim") == r["dim"]), r["n"], r["most"], asks, k, max_pivots)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
