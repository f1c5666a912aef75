import hashlib

from hypothesis import given, settings, strategies as st

from helpers import by_id, documents, odd_texts
from tillbook.llm import decontaminate
from tillbook.llm.common import words
from tillbook.llm.decontaminate import WINDOW, contamination, searchers, windows

RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def brute(text, items):
    found = words(text)
    hit, met = set(), set()
    for item, item_text in items:
        for window in windows(item_text):
            for i in range(len(found) - len(window) + 1):
                if tuple(found[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    met.add(str(item))
    digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
    return len(found), len(hit), len(met), digest, bool(hit) and 20 * len(hit) >= len(found)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=14).map(tuple), min_size=1, max_size=12, unique=True),
    st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60),
)
def test_wu_manber_finds_what_plain_search_finds(patterns, text):
    found = sorted(x for s in searchers(patterns) for x in s.search(text))
    plain = [(i, p) for p in patterns for i in range(len(text) - len(p) + 1) if tuple(text[i : i + len(p)]) == p]
    assert found == sorted(plain)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def items():
    long = " ".join(f"w{i}" for i in range(30))
    return [(1, long), (2, "short item here"), (3, None), (4, ""), (10, "w5 w6, W7! w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18"), (11, "single")]


def texts():
    filler = " ".join(f"f{i}" for i in range(400))
    run = " ".join(f"W{i}" for i in range(4, 22))
    return [
        (20, f"{filler} {run}"), (21, run), (22, f"{filler} Short, ITEM - here {filler} short item here"), (23, filler),
        (24, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (25, "SINGLE single"), *odd_texts(),
    ]


def test_against_brute_force(spark):
    frame = documents(spark, texts(), extra="n_words contaminated items _spans _items")
    result = contamination(frame, benchmark(spark, items()))
    assert set(result.columns) == {*frame.columns, *RESULT}
    assert {(r["_spans"], r["_items"]) for r in result.collect()} == {("clash", "clash")}
    rows = by_id(result, *RESULT)
    for doc_id, text in texts():
        assert rows[doc_id] == brute(text, items()), doc_id
    assert result.count() == len(texts())


def test_many_blocks_give_the_same(spark):
    frame = documents(spark, texts())
    whole = by_id(contamination(frame, benchmark(spark, items())), *RESULT)
    assert by_id(contamination(frame, benchmark(spark, items()), block_windows=7), *RESULT) == whole


def test_empty_tables(spark):
    frame = documents(spark, texts())
    clean = contamination(frame, benchmark(spark, []))
    assert clean.where("contaminated OR n_hit > 0").count() == 0
    assert contamination(frame.limit(0), benchmark(spark, items())).count() == 0


def test_windows_of_an_item():
    assert len(windows(" ".join(map(str, range(20))))) == 20 - WINDOW + 1
    assert windows("a b") == {(b"a", b"b")} and not windows("?!") and not windows(None)
    assert decontaminate._merged([(5, 7), (0, 3), (2, 4)]) == [0, 4, 5, 7]
