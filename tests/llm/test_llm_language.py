import numpy as np

from compare import TEST_DATA
from helpers import by_id, documents, odd_texts
from tillbook.llm import language
from tillbook.llm.language import Profiles, grams, identify, learn, ranked
from tillbook.llm.queries import QUERIES


def plain_grams(text):
    joined = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            gram = joined[i : i + n]
            if gram != " " and not (n == 3 and gram[1] == " "):
                code = 0
                for c in gram:
                    code = code << 21 | ord(c)
                counts[code] = counts.get(code, 0) + 1
    return counts


def test_grams_against_plain_code():
    for text in ("Hello, wörld! 12 abc", "a", "..x..", "ÀÉ 漢字 \U00010400b", "one  two\n\nthree"):
        codes, counts = grams(text)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == plain_grams(text)
    assert not len(grams("12 ?!")[0]) and not len(grams("")[0]) and not len(grams(None)[0])


def test_distance_is_out_of_place():
    profile = ranked("abc abd abe", 300).tolist()
    profiles = Profiles({"x": profile, "y": list(reversed(profile))}, 300)
    own = ranked("abc abd", 300)
    for column, list_ in enumerate((profile, profile[::-1])):
        expected = sum(abs(i - list_.index(g)) if g in list_ else 300 for i, g in enumerate(own.tolist()))
        assert profiles.distances(own)[column] == expected
    assert profiles.predict("abc abd abe") == ("x", 1.0)
    assert profiles.predict("漢字")[1] == 0.0


def test_ties_go_to_the_first_name():
    same = ranked("abc", 300).tolist()
    assert Profiles({"b": same, "a": same}, 300).predict("abc")[0] == "a"


def test_held_out_accuracy_and_training_rows_only(spark):
    frame = QUERIES["op3_language_id"](spark, f"{TEST_DATA}/sf0.01")
    truth = spark.read.parquet(f"{TEST_DATA}/sf0.01/documents.parquet")
    rows = frame.join(truth.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    texts = [*odd_texts(), (30, "the cat and the dog", "en", "s"), (31, "der Hund und die Katze", "de", "s"), (32, "x", None, None)]
    frame = documents(spark, texts, extra="score grams n chance")
    result = identify(frame, learn(frame))
    assert set(result.columns) == {*frame.columns, "lang_pred"}
    assert result.count() == len(texts)
    rows = by_id(result, "lang_pred", "score")
    assert all(rows[i] == (language.UNKNOWN, 0.0) for i in (1, 2, 3, 4))
    assert rows[31][0] == "de"


def test_empty_tables(spark):
    frame = documents(spark, [(1, "abc")])
    nothing = learn(frame.limit(0))
    assert by_id(identify(frame, nothing), "lang_pred", "score") == {1: ("und", 0.0)}
    assert identify(frame.limit(0), learn(frame)).count() == 0


def test_the_sample_bounds_training(spark):
    frame = spark.range(4000).selectExpr("id AS doc_id", "concat('word', id) AS text", "'en' AS lang")
    assert learn(frame, sample=50).languages == ["en"]
