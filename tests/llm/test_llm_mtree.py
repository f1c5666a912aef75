import math

import numpy as np
import pytest

from tillbook.llm import mtree
from tillbook.llm.mtree import Space, build, search, top_scores

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, top=5, step=50):
    usable = {}
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault((vec_id, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for q, qv in usable:
        if q % step == 0:
            scored = sorted({(-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in usable if i != q})[:top]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in top_scores(frame, **options).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("kind", ["clustered", "spread", "copies"])
def test_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(mtree, "PAGE", 200)
    monkeypatch.setattr(mtree, "LEAF", 24)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    points = rng.normal(size=(900, 12)) if kind == "spread" else centres[rng.integers(6, size=900)] + 0.1 * rng.normal(size=(900, 12))
    if kind == "copies":
        points[:400] = points[0]
    rows = [(int(i), [float(x) for x in p]) for i, p in enumerate(points)]
    assert found(spark, rows, query_step=30) == brute(rows, step=30)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]),
        (None, [3.0, 3.0]), (6, [0.5]), (7, []), (8, [-1.0, -1.0]), (9, [2.0**21, 3.0]), (250, [-(2.0**21), 2.0**21]), (100, [0.0, 0.0]), (150, [900_000.0, -900_000.0]), (11, [900_000.0, 1.0]),
    ]
    assert found(spark, rows) == brute(rows)
    few = [(0, [1.0]), (7, [2.0])]
    assert found(spark, few) == [(0, 1, 7, 131072)]
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(1, None)]) == []


def test_large_components_take_part(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(np.float32(x)) for x in p]) for i, p in enumerate(rng.normal(size=(120, 3)) * np.where(rng.random((120, 1)) < 0.3, 2.0**20, 1))]
    rows += [(1000, [2.0**21, -(2.0**21), 1.0]), (1050, [2.0**22, 0.5, 0.25])]
    assert found(spark, rows, query_step=10) == brute(rows, step=10)


def test_a_vector_whose_scores_cannot_fit_is_an_error(spark):
    with pytest.raises(Exception, match="vec_id 9 don't fit 64 bits"):
        found(spark, [(0, [1.0, 2.0]), (9, [1e30, 0.0])])


def test_empty_table(spark):
    assert top_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nodes_cover_their_vectors_and_bounds_save_work(monkeypatch):
    monkeypatch.setattr(mtree, "LEAF", 40)
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (20, 16))
    vectors = (centres[np.arange(2000) % 20] + rng.integers(-9, 9, (2000, 16))).astype(float)
    space = Space(16, int((vectors**2).sum(axis=1).max()))
    ids = np.arange(2000)
    nodes = build(ids, vectors, space)

    def members(number):
        node = nodes[number]
        return list(node["ids"]) if node["leaf"] else [m for c in node["children"] for m in members(c)]

    assert sorted(members(0)) == list(range(2000))
    for node in nodes:
        if not node["leaf"]:
            for child, centre, radius in zip(node["children"], node["vectors"], node["radii"], strict=True):
                assert space.between(vectors[members(child)], centre).max() <= radius + 1e-9
    computed = 0

    class Counted(np.ndarray):
        def __matmul__(self, other):
            nonlocal computed
            computed += len(self)
            return np.asarray(self) @ other

    watched = [{**n, "vectors": n["vectors"].view(Counted)} for n in nodes]
    best = search(watched, space, 0, vectors[0], 5, None)
    scores = vectors @ vectors[0]
    assert sorted(best, key=lambda b: (-b[0], b[1])) == sorted(((int(scores[i]), i) for i in range(1, 2000)), key=lambda b: (-b[0], b[1]))[:5]
    assert computed < 1500
