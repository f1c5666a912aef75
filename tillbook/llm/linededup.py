"""Line dedup: three consecutive lines that occur again anywhere are removed where they are repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.llm.common import hidden, written

#: Consecutive lines hashed together.
LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(documents: DataFrame, lines: int) -> DataFrame:
    """(doc_id, body, position, window): two 64-bit hashes of each window of non-blank trimmed lines.

    The position counts all lines, so a window reaches from its first to its last line.
    """
    numbered = F.transform(
        _lines(F.col("text")),
        lambda line, i: F.struct(i.cast("int").alias("at"), F.trim(line).alias("line")),
    )
    full = F.filter(numbered, lambda x: x["line"] != "")
    hashed = F.transform(
        full,
        lambda x: F.struct(
            x["at"].alias("at"),
            F.xxhash64(x["line"]).alias("a"),
            F.xxhash64(F.lit(1), x["line"]).alias("b"),
        ),
    )
    rows = documents.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("body"), hashed.alias("h")
    )
    rows = rows.where(F.size("h") >= lines)
    window = F.transform(
        F.sequence(F.lit(1), F.size("h") - (lines - 1)),
        lambda i: F.struct(
            F.element_at("h", i)["at"].alias("first"),
            F.element_at("h", i + (lines - 1))["at"].alias("last"),
            F.xxhash64(F.slice("h", i, lines)["a"]).alias("a"),
            F.xxhash64(F.slice("h", i, lines)["b"]).alias("b"),
        ),
    )
    return rows.select("doc_id", "body", F.explode(window).alias("w")).select("doc_id", "body", "w.*")


def covered_lines(documents: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, body, covered): the line positions that later occurrences cover, per document that has any.

    The first occurrence is that of the smallest doc_id (null first), then text hash and position.
    """
    windows = written(_windows(documents, lines), "windows")
    repeated = (
        windows.groupBy("a", "b")
        .agg(F.min(F.struct("doc_id", "body", "first")).alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    later = windows.join(written(repeated, "repeated"), ["a", "b"]).where(
        ~F.struct("doc_id", "body", "first").eqNullSafe(F.col("kept"))
    )
    return (
        later.select("doc_id", "body", F.explode(F.sequence("first", "last")).alias("at"))
        .groupBy("doc_id", "body")
        .agg(F.collect_set("at").alias("covered"))
    )


def _without(text: Column, positions: Column) -> Column:
    """The text without the lines at some positions, in time that grows with the lines alone.

    The lines are bound once as the only entry of an array, so that each is taken from the split text by
    its place, and the places that stay are a difference of sets, which is hashed.
    """

    def joined(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), positions)
        return F.array_join(F.transform(stay, lambda at: F.get(lines, at)), "\n")

    return F.get(F.transform(F.array(_lines(text)), joined), F.lit(0))


def remove_repeated_lines(documents: DataFrame, lines: int = LINES) -> DataFrame:
    """The documents with columns n_lines, n_removed and a text without the lines that repeat a window.

    Every window of three consecutive non-blank lines, trimmed, is compared with all others of
    the table. All its occurrences but the first go, overlapping ones merged, so a passage goes
    as a whole; blank lines inside it go with it. Texts of fewer lines, null and empty ones
    stay as they are (null has 0 lines); a text of which all lines repeat becomes empty. Rows
    that agree in doc_id and text are one document and are treated alike. All columns stay;
    of a name that the result needs, the result's column.

    The hashes are spread by window, a window that is very frequent is folded before the
    shuffle and its occurrences are joined by the adaptive skew join. Texts move once, by document.
    """
    own_id, own_body, gone = hidden(documents, "_id", "_body", "_covered")
    covered = covered_lines(documents, lines).toDF(own_id, own_body, gone)
    rest = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    joined = documents.select(*(F.col(f"`{c}`") for c in rest)).join(
        covered,
        F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.md5("text") == F.col(own_body)),
        "left",
    )
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(gone)))
    n_lines = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0))
    return joined.select(
        *(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in rest),
        F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.greatest(F.size(gone), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
    )
