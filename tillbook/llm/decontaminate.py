"""Benchmark decontamination: Wu-Manber search for many word sequences at once.

The alphabet is words, so a pattern is a tuple of words and a block is one or two words.
Patterns of similar length share a searcher. Its shift table says how far the search may
jump when a block stands at the end of the window; a jump of 0 leads to the bucket of
patterns that end with this block, and each is compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillbook.llm.common import add_columns, hidden, map_slices, words, written

#: Consecutive words of a benchmark text that make a window.
WINDOW = 13
#: Windows that one searcher, and so one broadcast, holds; larger benchmarks are searched block by block.
BLOCK_WINDOWS = 50_000
#: A document is contaminated from this share of its words on, as (parts, of).
CONTAMINATED = (1, 20)

Pattern = tuple[bytes, ...]


class WuManber:
    """Finds all occurrences of patterns whose lengths lie between ``shortest`` and twice that."""

    def __init__(self, patterns: Iterable[Pattern]):
        patterns = list(patterns)
        self.shortest = min(map(len, patterns))
        self.block = min(2, self.shortest)
        self.furthest = self.shortest - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for pattern in patterns:
            for end in range(self.block, self.shortest + 1):
                block = self._block(pattern, end)
                jump = self.shortest - end
                self.shift[block] = min(jump, self.shift.get(block, self.furthest))
            self.bucket[self._block(pattern, self.shortest)].append(pattern)

    def _block(self, sequence, end: int):
        return sequence[end - 1] if self.block == 1 else (sequence[end - 2], sequence[end - 1])

    def search(self, text: list[bytes]) -> Iterable[tuple[int, Pattern]]:
        shift, furthest, shortest, single = self.shift, self.furthest, self.shortest, self.block == 1
        end, size = shortest, len(text)
        while end <= size:
            block = text[end - 1] if single else (text[end - 2], text[end - 1])
            jump = shift.get(block, furthest)
            if jump:
                end += jump
                continue
            start = end - shortest
            for pattern in self.bucket[block]:
                if tuple(text[start : start + len(pattern)]) == pattern:
                    yield start, pattern
            end += 1


def searchers(patterns: Iterable[Pattern]) -> list[WuManber]:
    """Lengths within a factor of two share a searcher, so a short pattern doesn't slow down the long ones."""
    by_length = defaultdict(list)
    for pattern in patterns:
        by_length[len(pattern).bit_length()].append(pattern)
    return [WuManber(group) for group in by_length.values()]


def windows(text: str | None, size: int = WINDOW) -> set[Pattern]:
    """The different windows of a benchmark text: one if it is shorter than a window, none without words."""
    found = words(text)
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def _pattern_table(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, window): each window of each item, words joined by blanks."""

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            ids, texts = batch.column("item").to_pylist(), batch.column("text").to_pylist()
            rows = [(i, b" ".join(w)) for i, t in zip(ids, texts, strict=True) for w in windows(t, size)]
            return {"item": [i for i, _ in rows], "window": [w for _, w in rows]}

        return run

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return map_slices(items, "item string, window binary", make)


def _blocks(benchmark: DataFrame, size: int, block_windows: int) -> list[DataFrame]:
    """The windows with their items, dealt by hash into blocks of about ``block_windows`` rows."""
    table = _pattern_table(benchmark, size).groupBy("window")
    table = written(table.agg(F.collect_set(F.coalesce("item", F.lit(""))).alias("items")), "windows")
    n_blocks = -(-max(1, table.count()) // block_windows)
    dealt = F.pmod(F.xxhash64("window"), F.lit(n_blocks))
    return [table.where(dealt == block) for block in range(n_blocks)]


def _with_hits(rows: DataFrame, block: DataFrame, held: list[str]) -> DataFrame:
    """The rows with the occurrences of one block's windows added to the columns ``held``: [start, end) of words, and items."""
    patterns = {tuple(bytes(r["window"]).split()): r["items"] for r in block.toLocalIterator()}
    sent = rows.sparkSession.sparkContext.broadcast(patterns)

    def make():
        items_of, found_by = sent.value, searchers(sent.value)

        def hits(text: str | None, spans: list[int], items: list[str]):
            sequence, met = words(text), set(items)
            found = list(zip(spans[::2], spans[1::2], strict=True))
            for searcher in found_by:
                for start, pattern in searcher.search(sequence):
                    met.update(items_of[pattern])
                    found.append((start, start + len(pattern)))
            return len(sequence), _merged(found), sorted(met)

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            columns = (batch.column(c).to_pylist() for c in ("text", *held))
            found = [hits(*row) for row in zip(*columns, strict=True)]
            return {
                "n_words": [n for n, _, _ in found],
                held[0]: [s for _, s, _ in found],
                held[1]: [i for _, _, i in found],
            }

        return run

    return add_columns(rows, f"n_words long, {held[0]} array<long>, {held[1]} array<string>", make)


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    merged: list[int] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    contaminated: tuple[int, int] = CONTAMINATED,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The documents with n_words, n_hit, n_items, items_sha256 and contaminated.

    n_hit counts the words inside any occurrence of a window, n_items the benchmark items that
    occur, items_sha256 digests their sorted ids. Null and empty texts have no words and are
    clean; repeated rows each get their result; columns named as the result's are replaced. An
    empty benchmark, and items without words, meet nothing; items without id count as one with
    an empty id.

    Texts are searched whole, in one pass without a shuffle. What is broadcast is bounded: a
    benchmark of more than ``block_windows`` windows is searched block by block, each pass
    adding its occurrences to those before.
    """
    spans, met = held = hidden(documents, "_spans", "_items")
    rows = documents.withColumns({spans: F.array().cast("array<long>"), met: F.array().cast("array<string>")})
    for number, block in enumerate(_blocks(benchmark, window, block_windows)):
        rows = _with_hits(written(rows, "benchmark-hits") if number else rows, block, held)
    parts, of = contaminated
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)
    added = {
        "n_hit": hit,
        "n_items": F.size(met).cast("long"),
        "items_sha256": F.sha2(F.array_join(met, ",").cast("binary"), 256),
        "contaminated": (hit > 0) & (of * hit >= parts * F.col("n_words")),
    }
    return rows.withColumns(added).drop(*held)
