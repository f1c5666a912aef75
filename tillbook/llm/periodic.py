"""Periodic runs of words: branching tandem repeats found in an enhanced suffix array.

A run of words with period q and length L holds the square of its last 2q words, and that square
branches: the word after it differs from the word that would go on with the period. So suffixes i and i + q
lie in one LCP interval of depth q exactly, below different children of it. For each interval the
suffixes of all children but the largest are tested: is the rank of the suffix ``depth`` words before
or behind within the interval too? Intervals come from one sweep of the LCP array with a stack; no tree is built.
Branching squares are then rotated to the left as long as they stay squares, and all rotations of one
square merge into its run.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillbook.llm.common import map_slices

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words whose suffixes are sorted together; a longer text is sorted alone.
BATCH_WORDS = 200_000
#: Words of the grams that must occur again around each word of a run.
_GRAM = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word each of ``n`` words becomes, or None if the document stays as it is.

    A rule of the query: by the CRC of the decimal id a tenth of all documents end in a repetition.
    """
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not n or doc_id is None:
        return None
    a = g % n
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % (1 + (n - a) // (3 + g % 8)))


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in their order, and the rank of each; by doubling, where only unsettled suffixes are sorted again.

    The last symbol must be one that occurs once.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.diff(text[order], prepend=-1) != 0
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    unsettled = np.flatnonzero(~(new & np.append(new[1:], True)))
    width = 1
    while len(unsettled):
        suffix = order[unsettled]
        key = rank[suffix] * n + rank[suffix + width]
        by_key = np.argsort(key)
        suffix, key = suffix[by_key], key[by_key]
        order[unsettled] = suffix
        new = np.diff(key, prepend=-1) != 0
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[suffix] = unsettled[first]
        unsettled = unsettled[~(new & np.append(new[1:], True))]
        width *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """For each place of the order, the words that its suffix shares with the one before; 0 at the first."""
    words, at, before = text.tolist(), rank.tolist(), np.append(-1, order[:-1])[rank].tolist()
    out, shared = [0] * len(words), 0
    for i, j in enumerate(before):
        if j < 0:
            shared = 0
            continue
        while words[i + shared] == words[j + shared]:
            shared += 1
        out[at[i]] = shared
        shared = shared - 1 if shared else 0
    return out


def smaller_children(lcp: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(depth, first, last, from, to): each LCP interval's ranks with a range of ranks of its children but the largest.

    One sweep: an interval on the stack keeps its depth, its first rank and where its children begin.
    """
    stack: list[tuple[int, int, list[int]]] = [(0, 0, [0])]
    for place in range(1, len(lcp) + 1):
        depth = lcp[place] if place < len(lcp) else 0
        child = place - 1
        while stack[-1][0] > depth:
            own, first, children = stack.pop()
            if len(children) == 2:
                middle = children[1]
                if middle - first <= place - middle:
                    yield own, first, place - 1, first, middle
                else:
                    yield own, first, place - 1, middle, place
            else:
                ends = [*children[1:], place]
                largest = max(range(len(children)), key=lambda c: ends[c] - children[c])
                if largest:
                    yield own, first, place - 1, first, children[largest]
                if ends[largest] < place:
                    yield own, first, place - 1, ends[largest], place
            child = first
        if not depth:
            continue
        if stack[-1][0] == depth:
            stack[-1][2].append(place)
        else:
            stack.append((depth, child, [child, place]))


def branching_squares(text: np.ndarray) -> np.ndarray:
    """(start, period) of the branching squares that a third copy precedes, as rows; by start and period."""
    order, rank = suffix_array(text)
    found = []
    tests = smaller_children(common_prefixes(text, order, rank))
    for some in itertools.batched(tests, 50_000):
        depth, first, last, begin, end = np.array(some, np.int64).T
        size = end - begin
        which = np.repeat(np.arange(len(size)), size)
        suffix = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[which]]
        depth, first, last = depth[which], first[which], last[which]
        for start in (suffix, suffix - depth):
            # copies at start - depth, start and start + depth, all in the interval, and another word after the last
            inside = (start - depth >= 0) & (start + 2 * depth < len(text))
            begins, q, low, high = start[inside], depth[inside], first[inside], last[inside]
            member = (rank[begins - q] >= low) & (rank[begins - q] <= high)
            for other in (begins, begins + q):
                member &= (rank[other] >= low) & (rank[other] <= high)
            member &= text[begins + q] != text[np.minimum(begins + 2 * q, len(text) - 1)]
            found.append(np.stack((begins[member], q[member]), axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def _rotations(text: np.ndarray, start: int, period: int) -> int:
    """How often the square at ``start`` can be moved one word to the left and stay one."""
    done, step = 0, 64
    while start - done > 0:
        step = min(step, start - done)
        low = start - done - step
        unequal = np.flatnonzero(text[low : low + step] != text[low + period : low + period + step])
        if len(unequal):
            return done + step - 1 - int(unequal[-1])
        done += step
        step *= 2
    return done


def runs_of(text: np.ndarray) -> list[Run]:
    """(start, length, period) of the runs of a text of symbols whose last one occurs once.

    Of squares with one end, the shortest period comes first; a longer one inside its run is a multiple of
    it, so it is the same run and isn't rotated again.
    """
    squares = branching_squares(text)
    squares = squares[np.lexsort((squares[:, 1], squares.sum(axis=1) + squares[:, 1]))]
    out: list[Run] = []
    end_before, begun = -1, 0
    for start, period in squares.tolist():
        end = start + 2 * period
        if end == end_before and start >= begun:
            continue
        low = start - _rotations(text, start, period)
        if end != end_before or low < begun:
            end_before, begun = end, low
        if end - low >= max(LEAST_WORDS, LEAST_PERIODS * period):
            out.append((low, end - low, period))
    return out


def _stretches(ids: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches in which a run can lie: all its grams occur again in the document.

    Any gram of a run has an equal one a period away within the run, as runs are long enough. Hashes may
    agree by accident, which only keeps more words.
    """
    n = len(ids) - _GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = document[:n].astype(np.uint64) * _MIX
    for i in range(_GRAM):
        key = (key ^ (key >> np.uint64(29)) ^ ids[i : i + n].astype(np.uint64)) * _MIX
    inside = np.flatnonzero(document[:n] == document[_GRAM - 1 :])
    order = inside[np.argsort(key[inside])]
    same = np.diff(key[order]) == 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    # a change of document ends a stretch, as no gram lies across it
    edge = np.diff(np.concatenate(([0], again.astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + _GRAM - 1
    long = end - begin >= LEAST_WORDS
    return begin[long], end[long]


def runs_of_documents(texts: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each of several texts of symbols, sorted by start and period; all suffixes are sorted together."""
    found: list[list[Run]] = [[] for _ in texts]
    if not texts:
        return found
    ids = np.concatenate(texts)
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths) - lengths
    starts, ends = _stretches(ids, np.repeat(np.arange(len(texts)), lengths))
    if not len(starts):
        return found
    symbols = int(ids.max()) + 1
    # after each stretch a symbol of its own, so that nothing is equal across its end
    joined = np.concatenate([x for k, (s, e) in enumerate(zip(starts, ends, strict=True)) for x in (ids[s:e], [symbols + k])])
    places = np.cumsum(ends - starts + 1) - (ends - starts + 1)
    for low, length, period in runs_of(joined):
        k = int(np.searchsorted(places, low, side="right")) - 1
        at = int(starts[k]) + low - int(places[k])
        owner = int(np.searchsorted(begins, at, side="right")) - 1
        found[owner].append((at - int(begins[owner]), length, period))
    return [sorted(set(runs), key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def _blank_split(text: str | None) -> list[bytes]:
    """What stands between blanks, tabs and line ends, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "replace").split()


def _result(words: list[bytes], runs: list[Run]) -> tuple:
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    start, length, period = best or (None, None, None)
    kept = itertools.compress(words, collapsed(len(words), runs).tolist()) if runs else words
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = 1000 * length // period if best else None
    return len(runs), start, length, period, milli, _digest(listed), hashlib.sha256(b" ".join(kept)).hexdigest()


_FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def find_runs(documents: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each document.

    A run is a stretch of words with smallest period q, of at least LEAST_WORDS words and LEAST_PERIODS periods,
    that can't be extended. start, length and period are those of the run with the greatest
    length / period (ties: least start, then period), null without runs; exponent_milli is a thousand
    times that quotient, rounded down. The digests are of all runs and of the words that stay when
    each run keeps its first period. ``plant`` first turns the end of every tenth document into a repetition.
    A null, empty or blank text has no words and no runs; repeated rows each get their row; a document without
    doc_id is never planted. Other columns are not looked at.

    One pass over whole texts without a shuffle. Memory grows with BATCH_WORDS or the longest text.
    """

    def make():
        def several(rows: list[tuple[list[bytes], np.ndarray]]) -> list[tuple]:
            found = runs_of_documents([ids for _, ids in rows])
            return [_result(words, runs) for (words, _), runs in zip(rows, found, strict=True)]

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            done: list[tuple] = []
            rows: list[tuple[list[bytes], np.ndarray]] = []
            symbol, held = defaultdict(itertools.count().__next__), 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = _blank_split(text.as_py())
                source = planted(doc_id, len(words)) if plant else None
                if source is not None:
                    words = list(map(words.__getitem__, source.tolist()))
                if held and held + len(words) > BATCH_WORDS:
                    done += several(rows)
                    rows, symbol, held = [], defaultdict(itertools.count().__next__), 0
                rows.append((words, np.fromiter(map(symbol.__getitem__, words), np.int64, len(words))))
                held += len(words)
            done += several(rows)
            return {"doc_id": batch.column("doc_id")} | {name: [row[i] for row in done] for i, name in enumerate(_FIELDS)}

        return run

    ddl = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    return map_slices(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ddl, make)
