"""Periodic runs against a search of all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from helpers import documents, odd_texts
from tillbook.llm import periodic
from tillbook.llm.periodic import find_runs, runs_of_documents, suffix_array


def plain_runs(words):
    """(start, length, period) by trying every period."""
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q) and i > start:
                out.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if plant and words and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    digests = ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))
    milli = best[1] * 1000 // best[2] if runs else None
    return str((doc_id, len(runs), *best, milli, *(hashlib.sha256(d.encode()).hexdigest() for d in digests)))


def check(spark, rows, plant=False, **more):
    frame = find_runs(documents(spark, rows, **more), plant)
    found = sorted(str(tuple(r)) for r in frame.collect())
    assert found == sorted(plain_row(i, t, plant) for i, t in rows)
    return frame


def some_text(rng):
    words = []
    for _ in range(rng.randint(0, 8)):
        kinds = rng.randint(1, 5)
        if rng.random() < 0.4:
            words += [rng.randrange(kinds) for _ in range(rng.randint(0, 60))]
        else:
            part = [rng.randrange(kinds + 1) for _ in range(rng.randint(1, 20))]
            words += (part * rng.randint(1, 15))[: rng.randint(1, 150)]
    return words


def test_random_texts_together_equal_all_periods():
    rng = random.Random(1)
    total = 0
    for _ in range(400):
        texts = [np.array(some_text(rng), np.int64) for _ in range(rng.randint(0, 5))]
        expected = [plain_runs(t.tolist()) for t in texts]
        assert runs_of_documents(texts) == expected
        total += sum(map(len, expected))
    assert total > 500


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120))
def test_short_alphabets(text):
    assert runs_of_documents([np.array(text, np.int64)]) == [plain_runs(text)]


def test_nested_runs_and_repetitions_of_repetitions():
    inner = [1, 2] * 13
    for text in ([*inner, 3] * 5, [5] * 400, [*([1] * 30), *([2] * 30)] * 4, [1, 1, 2] * 9 + [1, 1, 2, 3] * 8):
        found = runs_of_documents([np.array(text, np.int64)])
        assert found == [plain_runs(text)] and found[0]


def test_no_word_is_equal_across_documents():
    half = np.array([1, 2, 3] * 5, np.int64)
    assert runs_of_documents([half, half]) == [[], []]
    whole = np.concatenate((half, half))
    assert runs_of_documents([whole, half, whole]) == [[(0, 30, 3)], [], [(0, 30, 3)]]


def test_suffixes_are_sorted():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        text = np.append(rng.integers(0, 3, n), 9)
        order, rank = suffix_array(text)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        assert (order[rank] == np.arange(n + 1)).all()


def test_documents_with_planted_repetitions(spark, monkeypatch):
    monkeypatch.setattr(periodic, "BATCH_WORDS", 300)
    rng = random.Random(5)
    rows = [(k, " ".join(f"v{rng.randrange(40)}" for _ in range(rng.randint(0, 120)))) for k in range(300)]
    frame = check(spark, rows, plant=True)
    assert frame.where("n_runs > 0").count() > 5
    check(spark, rows)


def test_odd_rows(spark):
    again = "again and " * 40
    rows = [*odd_texts(), (20, again), (20, again), (None, again), (21, again + "again"), (22, "\x0b".join("ab" * 30)), (23, "x " * 23), (24, "x " * 24),
            (25, "İ ß " * 20), (26, "a b " * 30), (-5, "y " * 30)]
    frame = check(spark, rows, extra="start length period n_runs")
    assert frame.columns == ["doc_id", *periodic._FIELDS]
    check(spark, rows, plant=True)
    check(spark, [])


@pytest.mark.parametrize("words", [100_000])
def test_a_very_long_text(spark, words):
    text = " ".join(f"k{i % 977}" for i in range(words)) + " " + "same " * words
    row = find_runs(documents(spark, [(1, text)])).first()
    assert row["n_runs"] == 2 and (row["start"], row["length"], row["period"]) == (words, words, 1)


def test_ties_take_the_least_start(spark):
    text = " ".join(["a b c"] * 10 + ["stop"] + ["d e f"] * 10)
    row = find_runs(documents(spark, [(1, text)])).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (2, 0, 30, 3, 10_000)
