"""Exact top-k search: best-first search in M-trees that are kept as pages of metric nodes.

The largest inner product is the least Euclidean distance once every vector has one more
component that brings all to the same length: |q' - x'|^2 = |q|^2 + M - 2 q.x, where M is the
largest squared length. The vectors are divided among regions around pivots and regions into
pages; each page is an M-tree whose nodes are rows of a table, with covering radii and distances to the
parent. A query first searches its own region. Its k-th score then bounds the search elsewhere:
regions, nodes and entries that the triangle inequality puts beyond it are left out, most by a
stored distance alone, without computing another.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillbook.llm.common import map_batches, map_slices, written

#: Results of a query; every QUERY_STEP-th id is a query; components are multiplied by SCALE and rounded down.
TOP, QUERY_STEP, SCALE = 5, 50, 256
#: Vectors of a page, entries of a leaf, children of an inner node.
PAGE, LEAF, FANOUT = 4096, 512, 8
#: Bounds that leave out less than this share of a node's entries cost more to follow than to ignore.
_WORTH = 0.25
#: Regions at most; their pivots are broadcast.
MAX_PIVOTS = 1024
#: Squared lengths from here on leave no room for scores in 64 bits; a table with such a vector is refused.
LIMIT = 2.0**62
#: Room for rounding in distances, relative to their size.
_SLACK = 1e-9

_NODE = "region int, chunk int, node int, leaf boolean, ids binary, vectors binary, radii binary, away binary, children binary"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, v): vectors of integers; a row with a null id, vector or component, or one that isn't finite, goes.

    Any other vector stays; one so long that scores may not fit 64 bits is an error.
    """
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    parts = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    squared = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x * x)
    refused = F.raise_error(F.format_string("scores of vec_id %s don't fit 64 bits", F.col("vec_id").cast("string"))).cast("array<long>")
    fitting = F.when(squared < LIMIT, scaled.cast("array<long>")).otherwise(refused)
    return rows.select(F.col("vec_id").cast("long").alias("id"), fitting.alias("v"))


class Space:
    """Distances between padded integer vectors of one length after the extra component.

    Scores are exact: in doubles while they stay below 2**52, else in 64-bit integers. Components are kept in
    32 bits if all fit.
    """

    def __init__(self, size: int, longest: int):
        self.size, self.longest = size, longest
        narrow = longest < 2**60  # then every component is less than 2**30
        self.stored, self.kind = (np.int32, "array<int>") if narrow else (np.int64, "array<long>")
        self.exact = np.float64 if longest < 2**52 else np.int64

    def matrix(self, vectors: list[list[int]]) -> np.ndarray:
        if vectors and all(len(v) == self.size for v in vectors):
            return np.array(vectors, self.exact).reshape(len(vectors), self.size)
        out = np.zeros((len(vectors), self.size), self.exact)
        for row, v in zip(out, vectors, strict=True):
            row[: len(v)] = v
        return out

    def extra(self, matrix: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.longest - (matrix * matrix).sum(axis=1).astype(float)))

    def between(self, matrix: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Distance of each row from one vector, both as data."""
        flat = matrix.astype(float) - one.astype(float)
        more = self.extra(matrix) - self.extra(one[None])[0]
        return np.sqrt((flat * flat).sum(axis=1) + more * more)

    def from_scores(self, scores: np.ndarray, query_length: float) -> np.ndarray:
        """Distance of a query, whose extra component is 0, from vectors with these inner products."""
        return np.sqrt(np.maximum(0, query_length + self.longest - 2 * scores.astype(float)))


def build(ids: np.ndarray, vectors: np.ndarray, space: Space) -> list[dict]:
    """Nodes of an M-tree over a page's vectors, the root first.

    An entry of a leaf is a vector, with its distance to the node's routing vector. An entry of an
    inner node is a child's routing vector, with the child's covering radius and the same distance.
    """
    nodes: list[dict] = []

    def grow(members: np.ndarray, routing: np.ndarray) -> int:
        number = len(nodes)
        nodes.append({})
        if len(members) <= LEAF:
            own = vectors[members]
            nodes[number] = {
                "leaf": True, "ids": ids[members], "vectors": own, "radii": np.zeros(len(members)),
                "away": space.between(own, routing), "children": np.zeros(0, np.int64),
            }
            return number
        count = min(FANOUT, -(-len(members) // LEAF))
        chosen = members[np.linspace(0, len(members) - 1, count).astype(int)]
        nearest = np.stack([space.between(vectors[members], vectors[c]) for c in chosen]).argmin(axis=0)
        groups = [(c, members[nearest == i]) for i, c in enumerate(chosen) if (nearest == i).any()]
        if len(groups) == 1:  # all alike
            groups = [(c, part) for c, part in zip(chosen, np.array_split(members, count), strict=True)]
        centres = vectors[[c for c, _ in groups]]
        nodes[number] = {
            "leaf": False, "ids": ids[[c for c, _ in groups]], "vectors": centres,
            "radii": np.array([space.between(vectors[m], vectors[c]).max() for c, m in groups]),
            "away": space.between(centres, routing),
            "children": np.array([grow(m, vectors[c]) for c, m in groups], np.int64),
        }
        return number

    grow(np.arange(len(ids)), vectors[0])
    return nodes


def search(nodes: list[dict], space: Space, query_id: int, query: np.ndarray, top: int, floor: int | None) -> list[tuple[int, int]]:
    """(score, id) of the best vectors of a page, at most ``top``, leaving out scores below ``floor``.

    Nodes are taken from a heap by their least possible distance.
    """
    length = float((query.astype(float) ** 2).sum())
    best: list[tuple[int, int]] = []  # a heap of (score, -id)

    def reach() -> float:
        score = best[0][0] if len(best) == top else floor
        if score is None:
            return np.inf
        limit = float(space.from_scores(np.array([score]), length)[0])
        return limit + _SLACK * (limit + np.sqrt(length + space.longest))

    root_vector = nodes[0]["vectors"]
    heap: list[tuple[float, int, float | None]] = [(0.0, 0, None)] if len(root_vector) else []
    while heap:
        least, number, to_routing = heapq.heappop(heap)
        limit = reach()
        if least > limit:
            break
        node = nodes[number]
        near = slice(None)
        if to_routing is not None:  # the stored distances alone leave entries out
            kept = np.flatnonzero(np.abs(to_routing - node["away"]) - node["radii"] <= limit)
            near = kept if len(kept) <= (1 - _WORTH) * len(node["ids"]) else near
        scores = node["vectors"][near] @ query
        if node["leaf"]:
            ids = node["ids"][near]
            least_score = best[0][0] if len(best) == top else floor
            good = np.arange(len(ids)) if least_score is None else np.flatnonzero(scores >= least_score)
            for i in good.tolist():
                entry = (int(scores[i]), -int(ids[i]))
                if ids[i] == query_id:
                    continue
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            continue
        distances = space.from_scores(scores, length)
        bounds = np.maximum(0, distances - node["radii"][near])
        for bound, child, distance in zip(
            bounds.tolist(), node["children"][near].tolist(), distances.tolist(), strict=True
        ):
            if bound <= limit:
                heapq.heappush(heap, (bound, child, distance))
    return [(score, -negative) for score, negative in best]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, tuple]]:
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            yield row[:keys], row[keys:]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _in_regions(rows: DataFrame, space: Space, pivots: np.ndarray) -> DataFrame:
    """The rows (id, v) with the region of the nearest pivot, and the distance from it."""
    sent = rows.sparkSession.sparkContext.broadcast((space, pivots))

    def make():
        own, centres = sent.value

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            vectors = batch.column("v").to_pylist()
            matrix = own.matrix(vectors).astype(float)
            points = np.hstack([matrix, own.extra(matrix)[:, None]])
            near = (centres * centres).sum(axis=1) - 2 * points @ centres.T
            region = near.argmin(axis=1)
            distance = np.sqrt(((points - centres[region]) ** 2).sum(axis=1))
            return {"id": batch.column("id"), "v": batch.column("v"), "region": region, "distance": distance}

        return run

    return map_slices(rows, f"id long, v {space.kind}, region int, distance double", make)


def _pages(placed: DataFrame, chunks: Column, space: Space) -> DataFrame:
    """The nodes of all pages, a row each."""
    dealt = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int")).select("region", "chunk", "id", "v")
    schema = StructType.fromDDL(_NODE)
    sent = placed.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        arrow, own = to_arrow_schema(schema), sent.value

        def nodes(key, rows):
            ids = np.array([r[0] for r in rows], np.int64)
            for number, node in enumerate(build(ids, own.matrix([r[1] for r in rows]), own)):
                packed = [
                    np.ascontiguousarray(node[c], kind).tobytes()
                    for c, kind in (("ids", np.int64), ("vectors", own.stored), ("radii", float), ("away", float), ("children", np.int64))
                ]
                yield (*key, number, node["leaf"], *packed)

        key, rows = None, []
        for new, row in _runs(batches, 2):
            if new != key and rows:
                yield _batch(list(nodes(key, rows)), arrow)
                rows = []
            key = new
            rows.append(row)
        yield _batch(list(nodes(key, rows)) if rows else [], arrow)

    return map_batches(dealt.repartition("region", "chunk").sortWithinPartitions("region", "chunk", "id"), run, schema)


def _answers(pages: DataFrame, asked: DataFrame, space: Space, top: int) -> DataFrame:
    """(query_id, id, score): the best of each page that a query (region, chunk, query_id, q, floor) is sent to."""
    nodes = pages.select(
        "region", "chunk", F.lit(0).alias("kind"), F.col("node").cast("long").alias("number"), F.struct(*pages.columns[3:]).alias("page"),
        F.lit(None).cast(space.kind).alias("q"), F.lit(None).cast("long").alias("floor"),
    )
    sent_to = asked.select(
        "region", "chunk", F.lit(1).alias("kind"), F.col("query_id").alias("number"), F.lit(None).cast(nodes.schema["page"].dataType).alias("page"),
        "q", "floor",
    )
    keys = ["region", "chunk"]
    both = nodes.unionAll(sent_to).repartition(*keys).sortWithinPartitions(*keys, "kind", "number")
    schema = StructType.fromDDL("query_id long, id long, score long")
    sent = pages.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        arrow, own = to_arrow_schema(schema), sent.value
        key, tree, out = None, [], []

        def node_of(page: dict) -> dict:
            ids = np.frombuffer(page["ids"], np.int64)
            vectors = np.frombuffer(page["vectors"], own.stored).astype(own.exact).reshape(len(ids), own.size)
            radii, away = (np.frombuffer(page[c], float) for c in ("radii", "away"))
            children = np.frombuffer(page["children"], np.int64)
            return {"leaf": page["leaf"], "ids": ids, "vectors": vectors, "radii": radii, "away": away, "children": children}

        for new, (kind, number, page, q, floor) in _runs(batches, 2):
            if new != key:
                key, tree = new, []
            if kind == 0:
                tree.append(node_of(page))
            elif tree:
                out += [(number, i, s) for s, i in search(tree, own, number, own.matrix([q])[0], top, floor)]
            if len(out) >= 10_000:
                yield _batch(out, arrow)
                out = []
        yield _batch(out, arrow)

    return map_batches(both, run, schema)


def _best(answers: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _empty(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def top_scores(vectors: DataFrame, top: int = TOP, query_step: int = QUERY_STEP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` largest inner products of each query with all other vectors.

    Components become floor(``scale`` * x). Queries are the rows whose vec_id is divisible by
    ``query_step``. Equal scores go to the smaller vec_id; a query with fewer candidates has them all.
    Rows without id, null vectors and those with a null or non-finite component take no part; all others do,
    and where a score may not fit 64 bits (a scaled vector of length 2**31 or more) the query fails; shorter vectors are padded with zeros; a repeated row is one vector,
    of different vectors with one id each is a candidate under it, and is never an answer to a query of its
    own id. An empty table gives no rows. Other columns are not looked at.

    Every vector is indexed and the search is exact. Pages have a bounded size however
    large a region is, so copies in great number fill several pages. Queries go only to
    the pages they need, in blocks of rows; the driver holds pivots and one radius a region, at
    most ``MAX_PIVOTS``.
    """
    data = written(quantised(vectors, scale).distinct(), "vectors")
    length = F.aggregate("v", F.lit(0).cast("long"), lambda total, x: total + x.cast("long") * x.cast("long"))
    n, size, longest = data.agg(F.count("*"), F.max(F.size("v")), F.max(length)).first()
    if not n:
        return _empty(vectors)
    space = Space(size, longest)
    data = data.withColumn("v", F.col("v").cast(space.kind))
    count = int(np.clip(n // (PAGE // 2), 1, MAX_PIVOTS))
    picked = data.orderBy(F.xxhash64("id"), "v").limit(count).collect()
    centres = space.matrix([r["v"] for r in picked]).astype(float)
    pivots = np.unique(np.hstack([centres, space.extra(centres)[:, None]]), axis=0)
    placed = written(_in_regions(data, space, pivots), "regions")
    regions = placed.groupBy("region").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()
    chunks = {r["region"]: -(-r["n"] // PAGE) for r in regions}
    chunks_of = F.create_map(*(F.lit(x) for pair in chunks.items() for x in pair))[F.col("region")]
    pages = written(_pages(placed, chunks_of, space), "pages")

    queries = placed.where(F.col("id") % query_step == 0)
    every_chunk = F.explode(F.sequence(F.lit(0), chunks_of - 1)).alias("chunk")
    asked = queries.select("region", every_chunk, F.col("id").alias("query_id"), F.col("v").alias("q"), F.lit(None).cast("long").alias("floor"))
    home = written(_best(_answers(pages, asked, space, top).distinct(), top).drop("rank"), "home")
    floors = home.groupBy("query_id").agg(F.when(F.count("*") >= top, F.min("score")).alias("floor"))
    bounded = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("region").alias("home"))
    bounded = bounded.join(floors, "query_id", "left")
    radii = {r["region"]: r["radius"] for r in regions}
    away = _routes(bounded, space, pivots, radii).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks_of - 1)))
    found = home.unionAll(_answers(pages, away, space, top)).distinct()
    return _best(found, top).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _routes(queries: DataFrame, space: Space, pivots: np.ndarray, radii: dict[int, float]) -> DataFrame:
    """(region, query_id, q, floor): other regions whose covering radius leaves room for a better score."""
    sent = queries.sparkSession.sparkContext.broadcast((space, pivots, radii))

    def make():
        own, centres, reach = sent.value
        regions = np.array(sorted(reach))
        radius = np.array([reach[r] for r in regions])

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {"region": [], "query_id": [], "q": [], "floor": []}
            columns = (batch.column(c).to_pylist() for c in ("query_id", "q", "home", "floor"))
            for query_id, q, home, floor in zip(*columns, strict=True):
                point = own.matrix([q])[0].astype(float)
                length = float(point @ point)
                distance = np.sqrt(((centres[regions, :-1] - point) ** 2).sum(axis=1) + centres[regions, -1] ** 2)
                limit = np.inf if floor is None else float(own.from_scores(np.array([floor]), length)[0])
                room = distance - radius <= limit + _SLACK * np.sqrt(length + own.longest)
                for region in regions[room & (regions != home)].tolist():
                    for name, value in zip(out, (region, query_id, q, floor), strict=True):
                        out[name].append(value)
            return out

        return run

    return map_slices(queries, f"region int, query_id long, q {space.kind}, floor long", make)
