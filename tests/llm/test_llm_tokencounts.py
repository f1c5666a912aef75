from hypothesis import given, settings, strategies as st

from helpers import by_id, documents, odd_texts
from tillbook.llm import tokencounts
from tillbook.llm.tokencounts import CountTree, count_tokens, count_with, counted, encoder, ranks, scrub_edits, segments

with open(tokencounts.VOCABULARY, "rb") as file:
    VOCABULARY = file.read()


def count(text):
    return len(encoder(VOCABULARY).encode_ordinary(text))


TEXT = st.text(st.sampled_from("ab cDé ñ.,'s\n\t12²  漢"), max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_segments_add_up(text):
    pieces = segments(text, 8)
    assert "".join(pieces) == text
    assert sum(map(count, pieces)) == count(text)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 420), st.integers(0, 60), TEXT.map(lambda t: t[:40])), max_size=8))
def test_edits_keep_the_tree_right(text, edits):
    tree = CountTree(text, count, 8)
    for start, size, new in edits:
        start = min(start, len(text))
        end = min(start + size, len(text))
        text = text[:start] + new + text[end:]
        tree.edit(start, end, new)
        assert tree.text == text
        assert tree.total == count(text)
        assert tree.characters[1] == len(text)


def test_an_edit_encodes_only_its_surroundings():
    text = "many plain words stand here in a row " * 3000
    tree = CountTree(text, count)
    assert tree.edit(50_000, 50_005, "other") < 2000
    assert tree.total == count(text[:50_000] + "other" + text[50_005:])


def test_growth_at_one_place_stays_right():
    tree, text = CountTree("a b c", count, 16), "a b c"
    for i in range(300):
        tree.edit(2, 2, f"word{i} in between ")
        text = f"{text[:2]}word{i} in between {text[2:]}"
    assert tree.text == text and tree.total == count(text)


def test_long_runs():
    encoding = encoder(VOCABULARY)
    for text in ("a" + " " * 20_000 + "b c", "\n" * 15_000, " \t" * 8_000 + "\nword", "x" + "\u3000" * 12_000 + "\ny"):
        assert count_with(encoding, text) == count(text)
    assert count_with(encoding, "a b" + " " * 1_200_000 + "c") > 2
    long = "a.b-" * 300_000 + "@"
    assert len(scrub_edits(long)) == 0


def test_positions_refer_to_the_text_before_edits():
    text = "one 1234567890 two me@example.com three"
    before, after, size, _ = counted(text, scrub_edits(text), count)
    assert before == count(text)
    assert after == count("one [number] two [address] three") and size == len("one [number] two [address] three")
    overlapping = [(0, 7, "X"), (4, 14, "Y")]
    assert counted(text, overlapping, count)[1] == count("X" + text[7:])


def test_odd_rows_and_an_edit_column(spark):
    vocabulary = ranks(spark)
    frame = documents(spark, odd_texts(), extra="n_tokens count row")
    result = count_tokens(frame, vocabulary, scrub_edits)
    assert result.count() == len(odd_texts())
    rows = by_id(result, "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded")
    for doc_id, text in odd_texts():
        assert rows[doc_id][0] == count(text or ""), doc_id
    assert rows[1] == (0, 0, 0, 0)
    edited = spark.createDataFrame(
        [(1, "abc def", [(0, 3, "xyz"), None, (90, 99, None)]), (2, "abc", None), (3, None, [(0, 5, "new")])],
        "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>",
    )
    rows = by_id(count_tokens(edited, vocabulary), "n_tokens", "n_tokens_edited", "n_chars_edited")
    assert rows[1][1:] == (count("xyz def"), 7)
    assert rows[2] == (count("abc"), count("abc"), 3)
    assert rows[3] == (0, count("new"), 3)
    assert count_tokens(edited.limit(0), vocabulary).count() == 0
