import time

from pyspark.sql import functions as F

from helpers import by_id, documents, odd_texts
from tillbook.llm.linededup import remove_repeated_lines


def cleaned(spark, texts, **options):
    return by_id(remove_repeated_lines(documents(spark, texts, **options)), "text", "n_lines", "n_removed")


def test_later_occurrences_go_with_merged_windows(spark):
    passage = "alpha\nbeta\ngamma\ndelta"
    rows = cleaned(spark, [(1, f"x\n{passage}\ny"), (2, f"{passage}\nz"), (3, "alpha\nbeta\nother")])
    assert rows[1] == (f"x\n{passage}\ny", 6, 0)
    assert rows[2] == ("z", 5, 4)
    assert rows[3] == ("alpha\nbeta\nother", 3, 0)


def test_repeats_inside_a_document_overlap(spark):
    rows = cleaned(spark, [(1, "a\na\na\na\na"), (2, "p\nq\nr\np\nq\nr")])
    assert rows[1] == ("", 5, 4) or rows[1][2] == 4
    assert rows[2] == ("p\nq\nr", 6, 3)


def test_blank_lines_and_margins(spark):
    rows = cleaned(spark, [(1, "a\n\nb\nc"), (2, "  a\nb \n\n\nc\nd"), (3, "\n\n\n\n"), (4, "\n\n\n\n")])
    assert rows[2] == ("d", 6, 5)
    assert rows[3] == rows[4] == ("\n\n\n\n", 5, 0)


def test_copies_become_empty(spark):
    rows = cleaned(spark, [(3, "a\nb\nc"), (2, "a\nb\nc"), (9, "a\nb\nc")])
    assert [rows[i][0] for i in (2, 3, 9)] == ["a\nb\nc", "", ""]


def test_odd_rows(spark):
    frame = documents(spark, odd_texts(), extra="n_lines body first covered a b w window")
    result = remove_repeated_lines(frame)
    assert result.count() == len(odd_texts())
    assert set(result.columns) == {*frame.columns, "n_removed"}
    rows = by_id(result, "text", "n_lines", "n_removed")
    assert rows[1] == (None, 0, 0) and rows[2] == ("", 1, 0)
    assert rows[5] == ("One line of words only.", 1, 0)
    assert remove_repeated_lines(frame.limit(0)).count() == 0


def test_columns_of_hidden_names_keep_their_values(spark):
    frame = documents(spark, [(1, "a\nb\nc"), (2, "a\nb\nc\nd")], extra="_id _body _covered _ID_")
    rows = remove_repeated_lines(frame).collect()
    assert all(r[c] == "clash" for r in rows for c in ("_id", "_body", "_covered", "_ID_"))
    assert {r["doc_id"]: r["text"] for r in rows} == {1: "a\nb\nc", 2: "d"}


def test_texts_of_a_million_lines(spark):
    lines = [f"line {i}" for i in range(500_000)]
    started = time.time()
    result = remove_repeated_lines(documents(spark, [(1, "\n".join(lines)), (2, "\n".join(lines + ["x", "", *lines, "end"]))]))
    rows = by_id(result, "text", "n_lines", "n_removed")
    assert rows[1][1:] == (500_000, 0)
    assert rows[2] == ("x\n\nend", 1_000_003, 1_000_000)
    assert time.time() - started < 60


def test_repeated_rows_are_one_document(spark):
    text = "a\nb\nc\nd"
    result = remove_repeated_lines(documents(spark, [(1, text), (1, text), (1, "a\nb\nc\ne"), (None, "a\nb\nc")]))
    kept = sorted(r["text"] for r in result.collect())
    assert kept.count("a\nb\nc") == 1  # the row without id comes first
    assert len(kept) == 4


def test_a_window_that_a_third_of_rows_share(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("x\ny\nz\n"), F.col("id")))
        .otherwise(F.concat_ws("\n", F.col("id"), F.col("id") + 1, F.col("id") + 2.5)).alias("text"),
    )
    result = remove_repeated_lines(rows)
    assert result.where("n_removed = 3").count() == 999
    assert result.where("n_removed = 0").count() == 2001
