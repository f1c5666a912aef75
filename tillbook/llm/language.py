"""Language ID: the n-grams of a text in order of frequency against the profile of each language."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillbook.llm.common import add_columns, map_slices

#: Characters of an n-gram: 1 up to this (three code points fit 64 bits).
MAX_N = 3
#: Most frequent n-grams of a text or language that are ranked.
RANKED = 300
#: Documents of a language that its profile is learned from, about; chosen by a hash of doc_id.
SAMPLE_PER_LANGUAGE = 2000
#: More languages than this are taken for a wrong column.
MAX_LANGUAGES = 10_000
UNKNOWN = "und"

_BITS = 21
_BLANK = 32


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text, packed, ascending, and how often each occurs; none without a letter.

    Letters in lower case; what stands between them is one blank, also before the first and
    after the last word. N-grams lie inside a word and its two blanks.
    """
    none = np.empty(0, np.int64)
    if not text:
        return none, none
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _is_letter()[codes]
    if not letter.any():
        return none, none
    codes = np.where(letter, codes, _BLANK)
    codes = codes[letter | np.concatenate(([False], letter[:-1]))]
    codes = np.concatenate(([_BLANK] if codes[0] != _BLANK else [], codes, [_BLANK] if codes[-1] != _BLANK else []))
    codes = codes.astype(np.int64)
    two = codes[:-1] << _BITS | codes[1:]
    three = two[:-1] << _BITS | codes[2:]
    return np.unique(
        np.concatenate((codes[codes != _BLANK], two, three[codes[1:-1] != _BLANK])), return_counts=True
    )


def ranked(text: str | None, size: int) -> np.ndarray:
    """The most frequent n-grams first; of equally frequent ones the smaller code."""
    codes, counts = grams(text)
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Rank of each n-gram in each language; languages in alphabetic order."""

    def __init__(self, lists: dict[str, list[int]], size: int = RANKED):
        self.languages, self.size = sorted(lists), size
        self.codes = np.unique(np.array([g for grams in lists.values() for g in grams], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int64)
        for column, language in enumerate(self.languages):
            own = np.array(lists[language], np.int64)
            self.ranks[np.searchsorted(self.codes, own), column] = np.arange(len(own))

    def distances(self, text_grams: np.ndarray) -> np.ndarray:
        """Sum of how far each n-gram is out of place; one that the language lacks counts ``size``."""
        at = np.searchsorted(self.codes, text_grams)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == text_grams[known]
        ranks = self.ranks[np.where(known, at, len(self.codes))]
        away = np.abs(ranks - np.arange(len(text_grams))[:, None])
        return np.where(ranks < 0, self.size, away).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language of least distance, the first by name of equals, and 1 less the distance's share of the largest."""
        own = ranked(text, self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        distances = self.distances(own)
        best = int(distances.argmin())
        return self.languages[best], float(1 - distances[best] / (len(own) * self.size))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def learn(
    labelled: DataFrame, size: int = RANKED, sample: int = SAMPLE_PER_LANGUAGE
) -> Profiles:
    """Profiles of the languages that the rows' lang names, from about ``sample`` whole texts of each.

    Rows without text or lang are left out. The sample is chosen by a hash of doc_id, in the
    scan, at a rate that follows from a count of rows per language; smaller languages are
    taken whole. Only the profiles reach the driver: ``size`` n-grams a language.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"lang holds more than {MAX_LANGUAGES} values")
    if not counts:
        return Profiles({}, size)
    rates = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))))
    chance = F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(2**32)) / F.lit(2.0**32)
    sampled = rows.where(chance < rates[F.col("lang")])

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            totals: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                totals.setdefault(lang, []).append(grams(text))
            out: dict[str, list] = {"lang": [], "gram": [], "n": []}
            for lang, found in totals.items():
                codes, inverse = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate([n for _, n in found]), len(codes))
                out["lang"] += [lang] * len(codes)
                out["gram"] += codes.tolist()
                out["n"] += sums.astype(np.int64).tolist()
            return out

        return run

    totals = map_slices(sampled.select("lang", "text"), "lang string, gram long, n long", make)
    totals = totals.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    lists: dict[str, list[int]] = {lang: [] for lang in counts}
    for row in totals.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place").collect():
        lists[row["lang"]].append(row["gram"])
    return Profiles(lists, size)


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """The documents with lang_pred and score, from the whole text alone.

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned. The score is 1
    where all n-grams are in the profile's place and 0 where it knows none of them. Repeated rows
    each get their result; equal distances go to the language first by name; columns named
    lang_pred or score are replaced. One pass without a shuffle; the profiles are broadcast
    (``RANKED`` n-grams a language).
    """
    sent = documents.sparkSession.sparkContext.broadcast(profiles)

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            found = [sent.value.predict(text) for text in batch.column("text").to_pylist()]
            return {"lang_pred": [language for language, _ in found], "score": [score for _, score in found]}

        return run

    return add_columns(documents, "lang_pred string, score double", make)
