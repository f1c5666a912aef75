"""Secret scans: patterns for known kinds, and Markov models of characters for the unknown ones."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillbook.llm.common import add_columns, map_slices

#: The kinds in their order, the patterns, and the least size of what counts.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS, _ACCESS_SIZE = re.compile("AKIA[A-Z0-9]+"), 20
_HEX, _HEX_SIZE = re.compile("[0-9a-f]+"), 24
_ASSIGN_SIZE = 6

#: A string of these characters, of at least this size and of two kinds of characters, is judged by the models.
_STRING = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_STRING_SIZE = 16
#: Log-likelihood ratio from which a string is random rather than an identifier.
LEAST_RATIO = 8.0
#: Documents that the models are trained on, about, chosen by a hash of doc_id.
SAMPLE = 20_000
#: Added to each count of a transition.
_SMOOTHING = 0.5

Span = tuple[int, int, int]


def _marked(characters: str) -> bytes:
    """A table that maps these characters to x and all other bytes to a blank."""
    return bytes(0x78 if chr(b) in characters else 0x20 for b in range(256))


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_HEX_MARKS = _marked(_DIGITS + "abcdef")
_STRING_MARKS = _marked(_LOWER + _UPPER + _DIGITS + "+/_=-")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the patterns' matches in code points, leftmost and non-overlapping per kind."""
    spans: list[Span] = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        spans += [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_SIZE]
    if "AKIA" in text:
        spans += [(*m.span(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= _ACCESS_SIZE]
    if b"x" * _HEX_SIZE in text.encode("utf-8", "replace").translate(_HEX_MARKS):
        spans += [(*m.span(), 2) for m in _HEX.finditer(text) if len(m[0]) >= _HEX_SIZE]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def candidates(text: str, taken: Iterable[Span]) -> list[tuple[int, int]]:
    """Strings that the models judge: they don't overlap a span and mix small letters, capitals or digits."""
    if b"x" * _STRING_SIZE not in text.encode("utf-8", "replace").translate(_STRING_MARKS):
        return []
    # both lists rise, so one walk finds whether a span that begins before a string's end reaches into it
    begun, reach = sorted((s, e) for s, e, _ in taken), 0
    out, at = [], 0
    for m in _STRING.finditer(text):
        start, end = m.span()
        while at < len(begun) and begun[at][0] < end:
            reach = max(reach, begun[at][1])
            at += 1
        if reach <= start and _kinds_of(m[0]) > 1:
            out.append((start, end))
    return out


def _kinds_of(string: str) -> int:
    return sum(any(c in kind for c in string) for kind in (_LOWER, _UPPER, _DIGITS))


def transitions(strings: Iterable[str]) -> np.ndarray:
    """How often each ASCII character follows each; a line feed stands before and after a string."""
    counts = np.zeros((128, 128), np.int64)
    for string in strings:
        codes = np.frombuffer(f"\n{string}\n".encode("ascii"), np.uint8)
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return counts


def log_ratio(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Per transition, the logarithm of its probability in random strings less that in ordinary ones.

    Without any sample a model is uniform over all transitions.
    """
    used = np.zeros(128, bool)
    used[[ord(c) for c in _LOWER + _UPPER + _DIGITS + "+/_=-.\n"]] = True

    def logs(counts: np.ndarray) -> np.ndarray:
        smooth = counts + _SMOOTHING
        return np.log(smooth / smooth[:, used].sum(axis=1, keepdims=True))

    return logs(random) - logs(ordinary)


def score(string: str, ratios: np.ndarray) -> float:
    codes = np.frombuffer(f"\n{string}\n".encode("ascii"), np.uint8)
    return float(ratios[codes[:-1], codes[1:]].sum())


_WORD = re.compile(r"[A-Za-z0-9+/_=-]{3,}")


def learn(documents: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Log ratios learned from about ``sample`` whole texts, chosen in the scan by a hash of doc_id.

    What the patterns find there are the samples of random strings (of an assignment, its
    value); strings elsewhere are ordinary. Only two matrices of 128 x 128 counts a task are
    summed and reach the driver.
    """
    n = documents.where(F.col("text").isNotNull()).count()
    chance = F.pmod(F.xxhash64(F.lit("markov"), "doc_id"), F.lit(2**32)) / F.lit(2.0**32)
    rows = documents.where("text IS NOT NULL").where(chance < min(1.0, sample / max(1, n))).select("text")

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            random, ordinary = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                random += [_ASSIGN.match(text, s)[2] if kind == 0 else text[s:e] for s, e, kind in spans]
                at = 0
                for start, end, _ in spans:
                    ordinary += _WORD.findall(text[at:start]) if start > at else []
                    at = max(at, end)
                ordinary += _WORD.findall(text[at:])
            both = [transitions(random), transitions(ordinary)]
            kind, first, second = np.nonzero(np.stack(both))
            return {
                "kind": kind.tolist(),
                "first": first.tolist(),
                "second": second.tolist(),
                "n": np.stack(both)[kind, first, second].tolist(),
            }

        return run

    counted = map_slices(rows, "kind int, first int, second int, n long", make)
    counts = np.zeros((2, 128, 128), np.int64)
    for row in counted.groupBy("kind", "first", "second").agg(F.sum("n").alias("n")).collect():
        counts[row["kind"], row["first"], row["second"]] = row["n"]
    return log_ratio(counts[0], counts[1])


def _named(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def scan(documents: DataFrame, ratios: np.ndarray, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """The documents with n_assign, n_access, n_hex, n_random, base_sha256 and spans.

    spans lists kind:start:end of all finds, by start and then kind, in code points with the
    end exclusive; base_sha256 digests the list of the patterns' finds alone. A string that no pattern
    found is ``random`` if its log-likelihood ratio is at least ``least_ratio``. A null text counts
    as empty and has no spans; repeated rows each get their result; columns named as the
    result's are replaced. One pass over whole texts without a shuffle.
    """
    sent = documents.sparkSession.sparkContext.broadcast(ratios)

    def make():
        def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
            base = base_spans(text or "")
            more = [
                (s, e, 3) for s, e in candidates(text or "", base) if score(text[s:e], sent.value) >= least_ratio
            ]
            return base, sorted(base + more, key=lambda x: (x[0], x[2]))

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            found = [spans_of(text) for text in batch.column("text").to_pylist()]
            out: dict[str, list] = {
                f"n_{kind}": [sum(s[2] == number for s in every) for _, every in found]
                for number, kind in enumerate(KINDS)
            }
            out["base_sha256"] = [hashlib.sha256(_named(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [_named(every) for _, every in found]
            return out

        return run

    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return add_columns(documents, f"{counts}, base_sha256 string, spans string", make)
