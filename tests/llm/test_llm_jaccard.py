import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import by_id, documents, odd_texts
from tillbook.llm import jaccard
from tillbook.llm.components import components
from tillbook.llm.jaccard import BANDS, ROWS, least_matches, min_hashes, near_duplicates, shingles, survivors


def brute(rows, threshold=0.8):
    """{doc_id: (class_id, n_links)} over rows with unique ids."""
    sets = {i: set(shingles(t).tolist()) for i, t in rows}
    ids = sorted(sets)
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and shared >= threshold * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                links[a] += 1
                links[b] += 1
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: (top(i), links[i]) for i in ids}


def near_copies(seed, groups, largest):
    rng = random.Random(seed)
    rows, number = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, largest)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                text[rng.randrange(len(text))] = f"w{rng.randrange(5000)}"
            rows.append((number, " ".join(text)))
            number += 1
    return rows


@pytest.mark.parametrize("crowd,block", [(16, 128), (3, 4)])
def test_against_brute_force(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(3, 60, 9)
    found = by_id(near_duplicates(documents(spark, rows).repartition(5)), "class_id", "n_links")
    assert found == brute(rows)


def test_a_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*base[: i % 150], f"x{i}", *base[i % 150 + 1 :]])) for i in range(700)]
    rows += [(1000 + i, " ".join(f"y{i * 200 + k}" for k in range(40))) for i in range(50)]
    found = by_id(near_duplicates(documents(spark, rows)), "class_id", "n_links")
    assert found == brute(rows)


def test_odd_rows(spark):
    texts = [*odd_texts(), (40, "four words are here"), (41, "Four words, are here!"), (None, None), (None, "four words are here")]
    frame = documents(spark, texts, extra="class class_id sig body node component links")
    rows = [(r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates(frame).collect()]
    assert len(rows) == len(texts)
    for wordless in (1, 2, 3):
        assert (wordless, wordless, 0) in rows
    assert rows.count((5, 5, 1)) == 2
    assert {(6, 6, 1), (7, 6, 1), (40, 40, 2), (41, 40, 2), (None, 40, 2), (None, None, 0)} <= set(rows)
    assert near_duplicates(frame.limit(0)).count() == 0


def test_copies_that_are_a_third_of_all(spark):
    frame = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the same words in every third text").otherwise(F.concat(F.lit("a text of its own numbered "), F.col("id"))).alias("text"),
    )
    found = near_duplicates(frame)
    assert found.where("class_id = 0 AND n_links = 999").count() == 1000
    assert found.where("class_id = doc_id AND n_links = 0").count() == 2000


def test_min_hashes_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        a = rng.integers(1, 2**63, 300, np.uint64)
        b = np.concatenate((a[:240], rng.integers(1, 2**63, 60, np.uint64)))
        a, b = np.unique(jaccard._mixed(a)), np.unique(jaccard._mixed(b))
        errors.append((min_hashes(a) == min_hashes(b)).mean() - 240 / 360)
    assert abs(np.mean(errors)) < 0.02


def test_pruning_keeps_what_can_reach_the_threshold():
    rng = np.random.default_rng(2)
    n = BANDS * ROWS
    for similarity, least, most in ((0.85, 0.999, 1.0), (0.2, 0.0, 0.001)):
        left = rng.integers(0, 256, (4000, n)).astype(np.uint8)
        same = rng.random((4000, n)) < similarity
        right = np.where(same, left, rng.integers(0, 256, (4000, n))).astype(np.uint8)
        share = len(survivors(left, right, 0.8, 1e-6)) / 4000
        assert least <= share <= most
    steps = least_matches(0.8, 1e-6)
    assert list(steps) == sorted(steps)


def test_components_of_paths_stars_and_loops(spark):
    path = [(i + 1, i) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (9, 8), (8, 9)], "x long, y long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {5: 5} | {i: 5 for i in range(200, 260)} | {8: 8, 9: 8}
    assert components(edges.limit(0)).count() == 0


def test_components_of_sparse_random_graphs(spark):
    rng = np.random.default_rng(11)
    pairs = rng.integers(0, 400, (300, 2)).tolist() + [(1000 + i, 1001 + i) for i in range(300)] + [(1300, 399), (3, 3)]
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {node: top(node) for node in parent}
    assert len(found) == len(parent)


def test_another_size_against_brute_force(spark, monkeypatch):
    monkeypatch.setitem(globals(), "shingles", lambda text: jaccard.shingles(text, 2))
    rows = near_copies(5, 40, 7)
    assert by_id(near_duplicates(documents(spark, rows), size=2), "class_id", "n_links") == brute(rows)


def test_only_texts_and_bands_that_meet_others_are_shuffled(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60))) for i in range(400)]
    rows += [(400 + i, f"{rows[i][1]} z") for i in range(3)]
    left = []

    def counted(frame, ids, key):
        found = jaccard_reduced(frame, ids, key)
        left.append((frame.count(), found.count()))
        return found

    jaccard_reduced = jaccard.reduced
    monkeypatch.setattr(jaccard, "reduced", counted)
    result = by_id(near_duplicates(documents(spark, rows)), "class_id", "n_links")
    assert result == brute(rows)
    assert [n for n, _ in left] == [403 * BANDS, 403] and all(m * 20 < n for n, m in left)
