"""Small tables for the operators, with the odd rows every operator must take."""

from __future__ import annotations

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", extra=""):
    """Rows (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names if asked for."""
    rows = []
    for row in texts:
        doc_id, text, *rest = row
        rows.append((doc_id, text, *(rest or [lang, "s"]), len(text) if text is not None else None))
    frame = spark.createDataFrame(rows, DOCUMENT)
    names = {c: "clash" for c in extra.split()}
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit(v) for c, v in names.items()}) if names else frame


def odd_texts():
    """Null, empty, without letters, very long, repeated and null ids."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, "  \n\n \t"), (4, "12 34 !?"), (5, "One line of words only."), (5, "One line of words only."),
        (6, long), (7, long), (None, "Row without an id, as it may be."), (8, "ÄÖÜ ß ñ \U0001f600 ﬁ İ K ſ"), (9, "a\x00b\x01c"),
    ]


def by_id(frame, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}
